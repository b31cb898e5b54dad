"""The canonical line items and the raw tags each may be read from, first tag first.

Fixed values: field | statement | unit | kind | sign | sectors | candidate tags in priority order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIELDS_TEXT = """
revenue|income|USD|duration|as_reported||Revenues RevenuesNetOfInterestExpense RevenueFromContractWithCustomerExcludingAssessedTax RevenueFromContractWithCustomerIncludingAssessedTax SalesRevenueNet SalesRevenueGoodsNet
cost_of_revenue|income|USD|duration|as_reported||CostOfRevenue CostOfGoodsAndServicesSold CostOfGoodsSold CostOfServices
gross_profit|income|USD|duration|as_reported||GrossProfit
operating_expenses|income|USD|duration|as_reported||OperatingExpenses
rd_expense|income|USD|duration|as_reported||ResearchAndDevelopmentExpense
sga_expense|income|USD|duration|as_reported||SellingGeneralAndAdministrativeExpense
operating_income|income|USD|duration|as_reported||OperatingIncomeLoss
interest_expense|income|USD|duration|as_reported||InterestExpense InterestExpenseDebt InterestAndDebtExpense InterestExpenseBorrowings InterestExpenseOther InterestCostsIncurred
pretax_income|income|USD|duration|as_reported||IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments
income_tax_expense|income|USD|duration|as_reported||IncomeTaxExpenseBenefit
net_income|income|USD|duration|as_reported||NetIncomeLoss NetIncomeLossAvailableToCommonStockholdersBasic NetIncomeLossAttributableToParent ProfitLoss
net_income_to_common|income|USD|duration|as_reported||NetIncomeLossAvailableToCommonStockholdersBasic
eps_basic|per_share|USD/shares|duration|as_reported||EarningsPerShareBasic EarningsPerShareBasicAndDiluted
eps_diluted|per_share|USD/shares|duration|as_reported||EarningsPerShareDiluted EarningsPerShareBasicAndDiluted
dividends_per_share|per_share|USD/shares|duration|as_reported||CommonStockDividendsPerShareDeclared CommonStockDividendsPerShareCashPaid
total_assets|balance|USD|instant|as_reported||Assets
current_assets|balance|USD|instant|as_reported||AssetsCurrent
cash_and_equivalents|balance|USD|instant|as_reported||CashAndCashEquivalentsAtCarryingValue Cash CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents CashEquivalentsAtCarryingValue
short_term_investments|balance|USD|instant|as_reported||ShortTermInvestments MarketableSecuritiesCurrent AvailableForSaleSecuritiesCurrent
accounts_receivable|balance|USD|instant|as_reported||AccountsReceivableNetCurrent AccountsReceivableNet ReceivablesNetCurrent
inventory|balance|USD|instant|as_reported||InventoryNet EnergyRelatedInventory InventoryCrudeOilProductsAndMerchandise
ppe_net|balance|USD|instant|as_reported||PropertyPlantAndEquipmentNet
goodwill|balance|USD|instant|as_reported||Goodwill
intangible_assets|balance|USD|instant|as_reported||IntangibleAssetsNetExcludingGoodwill FiniteLivedIntangibleAssetsNet
total_liabilities|balance|USD|instant|as_reported||Liabilities
current_liabilities|balance|USD|instant|as_reported||LiabilitiesCurrent
accounts_payable|balance|USD|instant|as_reported||AccountsPayableCurrent AccountsPayableAndAccruedLiabilitiesCurrent
long_term_debt|balance|USD|instant|as_reported||LongTermDebtNoncurrent LongTermDebt LongTermDebtAndCapitalLeaseObligations LongTermNotesPayable UnsecuredLongTermDebt ConvertibleLongTermNotesPayable NotesPayable
short_term_debt|balance|USD|instant|as_reported||DebtCurrent ShortTermBorrowings LongTermDebtCurrent LongTermDebtAndCapitalLeaseObligationsCurrent
commercial_paper|balance|USD|instant|as_reported||CommercialPaper
total_equity|balance|USD|instant|as_reported||StockholdersEquity StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest
retained_earnings|balance|USD|instant|as_reported||RetainedEarningsAccumulatedDeficit
additional_paid_in_capital|balance|USD|instant|as_reported||AdditionalPaidInCapital AdditionalPaidInCapitalCommonStock CommonStocksIncludingAdditionalPaidInCapital
treasury_stock|balance|USD|instant|as_reported||TreasuryStockValue
operating_cash_flow|cashflow|USD|duration|as_reported||NetCashProvidedByUsedInOperatingActivities NetCashProvidedByUsedInOperatingActivitiesContinuingOperations
investing_cash_flow|cashflow|USD|duration|as_reported||NetCashProvidedByUsedInInvestingActivities NetCashProvidedByUsedInInvestingActivitiesContinuingOperations
financing_cash_flow|cashflow|USD|duration|as_reported||NetCashProvidedByUsedInFinancingActivities NetCashProvidedByUsedInFinancingActivitiesContinuingOperations
capex|cashflow|USD|duration|abs||PaymentsToAcquirePropertyPlantAndEquipment PaymentsToAcquireProductiveAssets
depreciation_amortization|cashflow|USD|duration|as_reported||DepreciationDepletionAndAmortization DepreciationAmortizationAndAccretionNet DepreciationAmortizationAndOther DepreciationAndAmortization Depreciation
stock_based_comp|cashflow|USD|duration|as_reported||ShareBasedCompensation
dividends_paid|cashflow|USD|duration|abs||PaymentsOfDividends PaymentsOfDividendsCommonStock
share_repurchases|cashflow|USD|duration|abs||PaymentsForRepurchaseOfCommonStock PaymentsForRepurchaseOfEquity
debt_issued|cashflow|USD|duration|as_reported||ProceedsFromIssuanceOfLongTermDebt
debt_repaid|cashflow|USD|duration|abs||RepaymentsOfLongTermDebt
net_change_in_cash|cashflow|USD|duration|as_reported||CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect CashAndCashEquivalentsPeriodIncreaseDecrease
fx_effect_on_cash|cashflow|USD|duration|as_reported||EffectOfExchangeRateOnCashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents EffectOfExchangeRateOnCashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsIncludingDisposalGroupAndDiscontinuedOperations EffectOfExchangeRateOnCashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsDisposalGroupIncludingDiscontinuedOperations EffectOfExchangeRateOnCashAndCashEquivalents EffectOfExchangeRateOnCashAndCashEquivalentsContinuingOperations
cash_from_discontinued_operations|cashflow|USD|duration|as_reported||NetCashProvidedByUsedInDiscontinuedOperations
discontinued_operating_cash_flow|cashflow|USD|duration|as_reported||CashProvidedByUsedInOperatingActivitiesDiscontinuedOperations
discontinued_investing_cash_flow|cashflow|USD|duration|as_reported||CashProvidedByUsedInInvestingActivitiesDiscontinuedOperations
discontinued_financing_cash_flow|cashflow|USD|duration|as_reported||CashProvidedByUsedInFinancingActivitiesDiscontinuedOperations
shares_outstanding|shares|shares|instant|as_reported||CommonStockSharesOutstanding EntityCommonStockSharesOutstanding
weighted_avg_shares_basic|shares|shares|duration|as_reported||WeightedAverageNumberOfSharesOutstandingBasic WeightedAverageNumberOfShareOutstandingBasicAndDiluted
weighted_avg_shares_diluted|shares|shares|duration|as_reported||WeightedAverageNumberOfDilutedSharesOutstanding WeightedAverageNumberOfShareOutstandingBasicAndDiluted
interest_income|income|USD|duration|as_reported||InterestIncomeExpenseNet InterestAndDividendIncomeOperating InterestIncomeOperating
comprehensive_income|income|USD|duration|as_reported||ComprehensiveIncomeNetOfTax
restructuring|income|USD|duration|as_reported||RestructuringCharges
impairment|income|USD|duration|as_reported||ImpairmentOfLongLivedAssetsHeldForUse GoodwillImpairmentLoss
deferred_revenue|balance|USD|instant|as_reported||ContractWithCustomerLiabilityCurrent DeferredRevenueCurrent
operating_lease_liability|balance|USD|instant|as_reported||OperatingLeaseLiabilityNoncurrent OperatingLeaseLiability
finance_lease_liability|balance|USD|instant|as_reported||FinanceLeaseLiabilityNoncurrent FinanceLeaseLiability
minority_interest|balance|USD|instant|as_reported||MinorityInterest
preferred_equity|balance|USD|instant|as_reported||PreferredStockValue PreferredStockValueOutstanding
acquisitions|cashflow|USD|duration|net||PaymentsToAcquireBusinessesNetOfCashAcquired
net_interest_income|income|USD|duration|as_reported|bank|InterestIncomeExpenseNet InterestIncomeExpenseAfterProvisionForLoanLoss
interest_income_total|income|USD|duration|as_reported|bank|InterestAndDividendIncomeOperating InterestAndFeeIncomeLoansAndLeases InterestIncomeOperating
noninterest_income|income|USD|duration|as_reported|bank|NoninterestIncome
noninterest_expense|income|USD|duration|as_reported|bank|NoninterestExpense
provision_for_credit_losses|income|USD|duration|as_reported|bank|ProvisionForLoanLeaseAndOtherLosses ProvisionForLoanAndLeaseLosses ProvisionForLoanLossesExpensed ProvisionForCreditLossExpenseReversal ProvisionForDoubtfulAccounts
total_deposits|balance|USD|instant|as_reported|bank|Deposits InterestBearingDepositLiabilities DepositsTotal
total_loans|balance|USD|instant|as_reported|bank|LoansAndLeasesReceivableNetReportedAmount FinancingReceivableExcludingAccruedInterestAfterAllowanceForCreditLoss NotesReceivableNet
premiums_earned|income|USD|duration|as_reported|insurance|PremiumsEarnedNet PremiumsEarnedNetPropertyAndCasualty PremiumsEarnedNetLife
claims_incurred|income|USD|duration|as_reported|insurance|PolicyholderBenefitsAndClaimsIncurredNet PolicyholderBenefitsAndClaimsIncurredGross LiabilityForClaimsAndClaimsAdjustmentExpenseIncurredClaims1
benefits_and_expenses|income|USD|duration|as_reported|insurance|BenefitsLossesAndExpenses
claims_reserve|balance|USD|instant|as_reported|insurance|LiabilityForClaimsAndClaimsAdjustmentExpense LiabilityForFuturePolicyBenefits
deferred_acquisition_costs|balance|USD|instant|as_reported|insurance|DeferredPolicyAcquisitionCosts DeferredPolicyAcquisitionCostsAndPresentValueOfFutureInsuranceProfitsNet
total_investments|balance|USD|instant|as_reported|insurance|Investments MarketableSecuritiesNoncurrent LongTermInvestments
rental_revenue|income|USD|duration|as_reported|reit|OperatingLeaseLeaseIncome RealEstateRevenueNet OperatingLeasesIncomeStatementLeaseRevenue
real_estate_net|balance|USD|instant|as_reported|reit|RealEstateInvestmentPropertyNet
real_estate_gross|balance|USD|instant|as_reported|reit|RealEstateInvestmentPropertyAtCost
"""

ROWS = [tuple(line.split("|")) for line in FIELDS_TEXT.strip().splitlines()]
FIELDS = [r[0] for r in ROWS]
TAGS = {r[0]: r[6].split() for r in ROWS}
UNIT = {r[0]: r[2] for r in ROWS}
KIND = {r[0]: r[3] for r in ROWS}
SIGN = {r[0]: r[4] for r in ROWS}
DOLLAR_FLOWS = [r[0] for r in ROWS if r[2] == "USD" and r[3] == "duration"]
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A", "10-KT", "10-KT/A")
QUARTERLY_FORMS = ("10-Q", "10-Q/A") + ANNUAL_FORMS


def registry(spark: SparkSession) -> DataFrame:
    """One row per (field, tag): field, tag, priority, n_tags, unit, kind, sign. Its size is fixed by the text above."""
    rows = [(f, tag, i, len(TAGS[f]), UNIT[f], KIND[f], SIGN[f]) for f in FIELDS for i, tag in enumerate(TAGS[f])]
    return spark.createDataFrame(rows, "field string, tag string, priority int, n_tags int, unit string, kind string, sign string")
